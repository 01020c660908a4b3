"""framelens: quality analytics for multi-view, time-ordered sequences on PySpark."""
