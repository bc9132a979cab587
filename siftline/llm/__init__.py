"""Training-data operators. Nothing outside this subpackage imports it; it imports nothing from the rest of siftline."""
