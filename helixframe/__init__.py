"""A PySpark-native analytics engine for genomic cohort data."""
