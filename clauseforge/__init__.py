"""Spark-native analytics for document question answering.

Every public function takes and returns DataFrames; nothing here keeps a
global session, and nothing runs an action unless its docstring says so.
"""

__version__ = "0.1.0"
