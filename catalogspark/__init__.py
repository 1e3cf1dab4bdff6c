"""Analytics over large catalogs of files, written as Spark DataFrame programs.

Sub-packages: ``sources`` (readers, writers, test views), ``functions`` (Column -> Column expressions),
``operators`` (DataFrame -> DataFrame jobs), ``plans`` (the registered queries with their checking SQL) and
``streaming`` (incremental runs).
"""
