"""quillmill: Spark-first operators for content-data pipelines."""
