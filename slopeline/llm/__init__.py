"""Training-data operators: quality rules, de-duplication, scoring, extraction, archives,
packing and token output. Nothing else in the library imports this subpackage."""
