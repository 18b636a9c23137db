"""Operators that prepare inspection dumps, reports and logs as training data.

Every operator takes and returns DataFrames. The record they share is the
dump: dump_id, cluster_id, node_ip, section and content, with the column names
as parameters, because landed tables differ in which of them they carry.
Nothing outside this package imports it.
"""
