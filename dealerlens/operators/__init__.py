"""dealerlens.operators."""
