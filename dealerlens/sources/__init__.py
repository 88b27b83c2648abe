"""dealerlens.sources."""
