"""Report, merge, pricing and audit operators over DataFrames."""
