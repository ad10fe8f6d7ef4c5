"""Relational operators over the node and edge tables. Every function takes and returns DataFrames."""
