"""Gaugewright: a PySpark-native engine that audits labelled tables and evaluates classifiers at scale."""
