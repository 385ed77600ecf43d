"""Training-data operators: packing, scoring, mixing, pseudonyms, chat trees, sharding, outliers, images, joins."""
