"""Recollect: conversation-log analytics and knowledge distillation on Spark DataFrames."""
