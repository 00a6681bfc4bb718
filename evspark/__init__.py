"""evspark: evidence-grounded analytics over document collections, expressed as Spark DataFrame plans."""
