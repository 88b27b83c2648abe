"""dealerlens.plans."""
