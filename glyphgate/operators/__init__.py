"""Detection, decoding, policy, repair and analytics over DataFrames."""
