from . import assembly, evaluation, kept, mining, retrieval, rules  # noqa: F401
