"""Sources of a code graph: working trees, git objects and logs, dependency manifests, documents and workspaces."""
