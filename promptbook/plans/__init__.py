"""Plan-level helpers: cutting lineage, sizing partitions."""
