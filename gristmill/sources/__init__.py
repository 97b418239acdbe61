"""Feed parsers and other inputs."""
