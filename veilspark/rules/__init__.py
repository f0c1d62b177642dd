from veilspark.rules.dialect import RuleError, to_java, word_pattern
from veilspark.rules.model import Matcher, RuleSet, check_document, check_on_spark, compile_rules, read_rules
from veilspark.rules.pack import default_rules

__all__ = [
    "Matcher", "RuleError", "RuleSet", "check_document", "check_on_spark", "compile_rules",
    "default_rules", "read_rules", "to_java", "word_pattern",
]
