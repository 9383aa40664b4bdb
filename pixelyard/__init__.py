"""pixelyard: analytics over image collections and benchmark runs, on Spark DataFrames."""
