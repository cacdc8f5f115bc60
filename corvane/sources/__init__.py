"""Sources and sinks: workspaces, Python source, git, diffs, configuration and table layouts."""
