"""Where data comes from: readers of the feeds' formats, and equity panels derived from the driver's tables."""
