"""Training-data operators: ten operators over document, page and conversation tables.

Nothing outside this subpackage imports it.  ``queries`` registers the thin
``opN_<name>`` queries; each operator module keeps a general interface.
"""
