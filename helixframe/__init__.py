"""helixframe: finding, masking and evaluating repeated sequence with Spark DataFrames."""
