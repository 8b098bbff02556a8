"""Tables of windows, segments, pairings and injections."""
