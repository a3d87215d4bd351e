"""Website-audit and text-matching jobs as Spark DataFrame transformations."""
