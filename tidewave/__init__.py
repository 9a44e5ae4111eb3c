"""A PySpark-native analytics engine for multichannel time series and their metadata."""
