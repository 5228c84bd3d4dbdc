"""Operators for training-data pipelines. Nothing else in telar imports this subpackage."""
