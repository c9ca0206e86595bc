"""minewright: data-mining operators for interaction data, written as Spark plans."""
