"""Framewright: Spark jobs for media datasets, model-evaluation results and training-data pipelines."""
