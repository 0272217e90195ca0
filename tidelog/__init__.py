"""tidelog: a Spark-native log analytics engine.

Every operator is a DataFrame -> DataFrame transform.  Catalyst plans them, Tungsten runs them; Python
workers are used only where the built-in expressions can't state the semantics (quote-aware record
assembly, balanced-brace scans, the text operators of the subpackage ``llm``).
"""

__version__ = "0.1.0"
