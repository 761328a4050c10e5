"""PLY and OBJ sources and sinks."""
