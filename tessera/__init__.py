"""tessera: Spark-native preparation, rule tagging, decoding and scoring of
token-labelled text corpora (personal-data detection)."""

__version__ = "0.1.0"
