"""Sources, sinks and the catalogue of datasets."""
