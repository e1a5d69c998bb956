"""proselake: prose-quality analytics and training-data curation on Spark."""
