"""DataFrame -> DataFrame operators of the corpus, dialog, token and metric pipelines."""
