"""Readers: driver tables, the league derived from them, CSV catalogues, strict JSON, synthetic leagues."""
