"""millrace: structured data pipelines as Spark DataFrames."""

from millrace.frame import Frame
from millrace.session import session

__all__ = ["Frame", "session"]
__version__ = "0.1.0"
