"""routeflow: message routing and event processing as Spark DataFrame transformations."""

__version__ = "0.1.0"
