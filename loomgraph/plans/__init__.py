"""Query compiler: syntax trees to DataFrames."""
