"""Where graphs come from: tables, CSV files, stored layers."""
