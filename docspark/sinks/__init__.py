"""Writers: delimited exports, replaced keys, index tables."""
