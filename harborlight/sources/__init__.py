"""Bundle and catalogue readers, and sinks."""
