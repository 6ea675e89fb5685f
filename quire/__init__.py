"""quire: lexicon-driven corpus analytics on PySpark.

Every operator is a lazy ``DataFrame -> DataFrame`` function; lexicons are input tables.
The subpackage ``quire.llm`` holds the training-data operators and is optional: nothing
outside it imports it.
"""
