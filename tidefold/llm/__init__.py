"""Operators that prepare training data: filters, near-duplicate joins, classifiers, token counting,
mixing and packing. Nothing outside this subpackage imports it; executors need the package on their
Python path (``--py-files``), as for any PySpark library."""
