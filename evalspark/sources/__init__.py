"""Sources, sinks and the bindings of the driver tables to operator inputs."""
