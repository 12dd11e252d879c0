"""Alignment-trace analytics on Apache Spark: DataFrame operators, codecs, sources and sinks."""
