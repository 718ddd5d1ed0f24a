"""Agent and LLM trace analytics as Spark DataFrame plans."""

from tracewright.options import Options

__all__ = ["Options"]
