"""The tables of each layer, and the order in which a run builds them."""
