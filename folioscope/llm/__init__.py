"""Training-data operators over ``documents``, ``pages``, ``benchmark`` and ``labels``.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and returns
DataFrames; the registered queries (``registry.py``) are thin wrappers over them.
"""
