from castlens.functions.columns import (WORD_SEPARATORS, array_get, concat_key, midpoint,
                                       safe_double, split_get, stable_bucket, word_tokens)

__all__ = ["WORD_SEPARATORS", "array_get", "concat_key", "midpoint", "safe_double", "split_get",
           "stable_bucket", "word_tokens"]
