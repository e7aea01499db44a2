"""Time-dependent behaviour over event tables and streams."""
