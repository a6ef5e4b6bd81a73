from .keys import bucket_of, int_list, path_parts, shard_of, slot_of
from .text import (
    analyzed,
    clean_markup,
    embedding_text,
    fragment,
    is_stop_word,
    long_enough,
    string_or_empty,
    trim_space,
    truncate,
    words,
)
from .vectors import cosine, dot, has_vector, norm, vector_from_json

__all__ = [
    "analyzed",
    "bucket_of",
    "clean_markup",
    "cosine",
    "dot",
    "embedding_text",
    "fragment",
    "has_vector",
    "int_list",
    "is_stop_word",
    "long_enough",
    "norm",
    "path_parts",
    "shard_of",
    "slot_of",
    "string_or_empty",
    "trim_space",
    "truncate",
    "vector_from_json",
    "words",
]
