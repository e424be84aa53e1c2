"""inkframe: raster-shape analytics and training-data operators as Spark DataFrame transformations."""
