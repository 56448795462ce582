"""Road-network conflation and comparison over DataFrames."""
