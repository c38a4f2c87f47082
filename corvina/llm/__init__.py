"""Training-data operators; nothing outside this subpackage imports it.

Every operator states in its docstring what nulls, empty and very long texts, ties and
repeated rows give, and leaves unrelated columns alone: inputs are first narrowed to the
columns it needs under private names, so extra or clashing columns do not matter.
"""
