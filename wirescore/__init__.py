"""Spark-native scoring of speech-to-text output under telephone-audio conditions."""
