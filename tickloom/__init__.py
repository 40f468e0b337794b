"""tickloom: bars, features, labels, rules and evaluation of many price series on Spark.

Every ordered computation runs on a panel ``(symbol, chunk, bar_no)``: a series is
cut into bounded chunks, so no task ever holds a whole series (see
``tickloom.operators.panel``).
"""
