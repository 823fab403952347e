"""tidewatch: behavioural analytics over entity event streams, as Spark plans."""
