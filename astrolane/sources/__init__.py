"""Container files as Spark sources and sinks, and the codecs of their tiles."""
