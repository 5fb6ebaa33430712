"""No operator streams: the batch ones have no counterpart over unbounded input."""
