"""siltstone: a content-addressed, versioned dataset engine expressed as Spark dataflows."""
