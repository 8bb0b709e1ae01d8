"""Spark-native graph analytics: graphs are vertex and edge DataFrames, algorithms are short loops of joins."""
