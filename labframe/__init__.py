"""labframe: bulk clinical-laboratory and text-corpus operators on Spark DataFrames."""
