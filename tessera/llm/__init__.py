"""Training-data operators: deduplication, decontamination, mixing, filters,
page text, sharding and vector search.  Nothing else in the library imports
this subpackage."""
