"""dealerlens.streaming."""
