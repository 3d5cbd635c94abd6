"""Operators for preparing training text; nothing else in the library imports this subpackage."""


def load():
    """The registry with all query modules imported."""
    from . import (  # noqa: F401
        byte_cnn, context_mixing, decontamination, exact_dedup, lexical_search, mixing, quality_rules, registry, resampling, simhash, substrings,
        suffix_dedup, token_files, url_filter,
    )

    return registry
