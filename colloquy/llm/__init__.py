"""Training-data operators: filtering, deduplication, mixing, packing and storage of documents.

Nothing outside this subpackage imports it.  Each module holds one operator; ``queries`` registers one
``opN_<name>`` query for each and the SQL where SQL can express it.
"""
