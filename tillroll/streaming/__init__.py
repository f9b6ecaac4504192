"""The aggregations over streams of files."""
