"""larkspan: landmark and sequence retrieval on Spark DataFrames."""
