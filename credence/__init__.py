"""credence: article-credibility analytics as Spark DataFrame operators.

Sub-packages:
  sources    - parquet/CSV sources, the labelled corpus, model stores
  functions  - Column expressions (text cleaning, tokens, labels, scores)
  operators  - DataFrame -> DataFrame operators (profile, tfidf, clusters, ...)
  plans      - fitted pipelines and the registry of named queries
  streaming  - Structured Streaming scoring
"""

__version__ = "0.1.0"
