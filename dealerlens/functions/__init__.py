"""dealerlens.functions."""
