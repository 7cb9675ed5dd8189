"""The boolean filter language over tags and annotations.

    expression := run { AND run }          run    := choice { choice }      (and)
    choice     := signed { OR signed }     signed := [ NOT | - ] body
    body       := name [ comparator argument ] | ( expression )
    name       := word { . word }          argument := name | ( expression )

OR binds tighter than AND, written or implied.
"""

from tidemark.filterlang.compile import Mode, compile_filter, evaluate
from tidemark.filterlang.tree import FilterError, parse, printed

__all__ = ["FilterError", "Mode", "compile_filter", "evaluate", "parse", "printed"]
