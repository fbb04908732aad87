"""Operators of a training-data pipeline: counting, matching, filtering, mixing and encoding texts at corpus scale.

Nothing outside this package imports it. The queries are registered in ``speechloom.llm.workload``.
"""
