"""barloom: price-bar analytics as Spark DataFrame operators.

Every operator takes a DataFrame keyed by ``(ticker, date)`` and returns a
DataFrame.  Nothing in the package sorts or collects a whole series in one
task: see :mod:`barloom.operators.panel` for the layout that makes the window
functions safe for a ticker that holds a large share of all rows.
"""

__version__ = "0.1.0"
