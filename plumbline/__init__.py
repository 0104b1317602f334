"""Analytics over construction takeoff, schedule and bid-document tables, declared as Spark plans."""

__version__ = "0.1.0"
