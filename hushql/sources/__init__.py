"""Where tables come from: Parquet read as temporary views, labelled by a catalog."""
