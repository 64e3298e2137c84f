"""Table operators. Every function takes and returns DataFrames or Columns."""
