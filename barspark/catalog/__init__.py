"""Every operator as a runnable query."""


def load():
    """The registry with all query modules imported."""
    from . import registry
    from . import q_bars, q_decisions, q_evaluation, q_features, q_incremental, q_normalize, q_quality, q_sources, q_streaming  # noqa: F401

    return registry
