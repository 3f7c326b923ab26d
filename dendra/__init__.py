"""dendra: Spark-native analytics for annotated dependency treebanks and text corpora."""

__version__ = "0.1.0"
