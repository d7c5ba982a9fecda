"""Spark-native static review of Python source trees, plus training-data operators in ``verdigris.llm``."""
